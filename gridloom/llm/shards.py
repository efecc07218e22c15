"""Token shards: ids of documents in ascending doc_id order, a wavelet matrix for each shard.

A wavelet matrix keeps one bit-plane for each bit of an id, highest first; below each plane the ids with a 0
come before those with a 1, in order. Ranks on the planes give the id at a place, counts and occurrences, so
one compressed file answers all of them.

A file holds, for each plane, the ones before each chunk of CHUNK bits and before each block of BLOCK bits
within its chunk, and each chunk compressed for itself: a rank or select inflates the one chunk it falls in.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, importable, shared_dir, tokenizer_file

MODEL, END = "word_bpe_49k.json", 2
#: Documents of a bucket of neighbouring ids, the most buckets, ids after which a bucket begins a further file.
SHARD_DOCS, MOST_BUCKETS, FILE_IDS = 4096, 16_384, 8_000_000
#: Characters that are encoded at once, parts of words that a worker remembers.
BATCH_CHARS, REMEMBERED = 16_000_000, 1_500_000
MAGIC, CHUNK, BLOCK = b"GLW2", 1 << 16, 512
#: Letters that lower-case to one letter and have no parts; punctuation that the tokenizer never joins to them.
LATIN, PUNCTUATION = "^[A-Za-zÀ-ÖØ-öø-ÿĀ-į]+$", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: What the quick way assumes of a tokenizer file: fixed values of the format.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WaveletMatrix:
    """Rank and select over the bit-planes of n ids in one file's bytes; chunks are inflated when they are asked for."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.data, (self.n, self.bits) = data, struct.unpack_from("<QI", data, 4)
        self.chunks, at = -(-self.n // CHUNK), 16
        self.zeros = np.frombuffer(data, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        size = self.bits * (self.chunks + 1)
        self.ones = np.frombuffer(data, "<u4", size, at).reshape(self.bits, -1)  # before each chunk, then in all
        at += 4 * size
        self.starts = np.frombuffer(data, "<u4", self.bits * self.chunks + 1, at) + np.uint32(0)
        at += 4 * (self.bits * self.chunks + 1)
        per = CHUNK // BLOCK
        self.blocks = np.frombuffer(data, "<u2", self.bits * self.chunks * per, at).reshape(self.bits, self.chunks, per)
        self.body = at + 2 * self.bits * self.chunks * per
        self._inflate = zstandard.ZstdDecompressor().decompress
        self.inflated: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def pack(ids: np.ndarray) -> bytes:
        """The file of ids."""
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        n, bits = len(ids), max(1, int(ids.max()).bit_length()) if len(ids) else 1
        chunks, cur = -(-n // CHUNK), ids
        zeros, ones, blocks, body = [], [], [], []
        for shift in range(bits - 1, -1, -1):
            one = (cur >> shift & 1).astype(bool)
            plane = np.zeros(chunks * CHUNK // 8, np.uint8)
            packed = np.packbits(one, bitorder="little")
            plane[: len(packed)] = packed
            per_block = np.bitwise_count(plane.view(np.uint64)).reshape(chunks, CHUNK // BLOCK, BLOCK // 64).sum(2, dtype=np.int64)
            ones.append(np.append(0, np.cumsum(per_block.sum(1))))
            blocks.append((np.cumsum(per_block, 1) - per_block).astype("<u2"))
            body += [squeeze(plane[a : a + CHUNK // 8].tobytes()) for a in range(0, len(plane), CHUNK // 8)]
            low = cur[~one]
            zeros.append(len(low))
            cur = np.concatenate([low, cur[one]])
        starts = np.cumsum([0, *map(len, body)]).astype("<u4")
        head = [MAGIC, struct.pack("<QI", n, bits), np.array(zeros, "<u8"), np.array(ones, "<u4"), starts, np.array(blocks, "<u2")]
        return b"".join([h if isinstance(h, bytes) else h.tobytes() for h in head] + body)

    def _chunk(self, k: int, c: int) -> np.ndarray:
        """Bytes of chunk c of plane k."""
        found = self.inflated.get((k, c))
        if found is None:
            at = k * self.chunks + c
            raw = self._inflate(self.data[self.body + int(self.starts[at]) : self.body + int(self.starts[at + 1])])
            found = self.inflated[k, c] = np.frombuffer(raw, np.uint8)
        return found

    def _bits(self, k: int, c: int) -> np.ndarray:
        return np.unpackbits(self._chunk(k, c), count=min(CHUNK, self.n - c * CHUNK), bitorder="little")

    def all(self) -> np.ndarray:
        """Every id in order, from the lowest plane up."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            one = np.concatenate([self._bits(k, c) for c in range(self.chunks)]).view(bool) if self.chunks else np.zeros(0, bool)
            up = np.empty_like(out)
            up[~one], up[one] = out[: self.zeros[k]], out[self.zeros[k] :]
            up |= one.astype(out.dtype) << out.dtype.type(self.bits - 1 - k)
            out = up
            self.inflated.clear()
        return out

    def _rank1(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones of plane k before each place, and its bit there (0 at the end)."""
        rank, bit = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        inside = at < self.n
        rank[~inside] = self.ones[k, -1]
        chunk = at // CHUNK
        for c in np.unique(chunk[inside]):
            here = np.flatnonzero(inside & (chunk == c))
            within = at[here] - c * CHUNK
            words = self._chunk(k, int(c)).view("<u8")
            block = within // BLOCK
            sums = np.bitwise_count(words).astype(np.int64)
            before = np.cumsum(sums) - sums  # of each word in the chunk
            word = within // 64
            own = words[word] & ((np.uint64(1) << (within % 64).astype(np.uint64)) - np.uint64(1))
            rank[here] = self.ones[k, c].astype(np.int64) + self.blocks[k, c, block] + before[word] - before[block * (BLOCK // 64)] + np.bitwise_count(own)
            bit[here] = (words[word] >> (within % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64)
        return rank, bit

    def _select(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Places of the nth (from 0) ones or zeros of plane k."""
        starts = np.minimum(np.arange(self.chunks + 1) * CHUNK, self.n)
        before = self.ones[k].astype(np.int64) if bit else starts - self.ones[k]
        chunk, out = np.searchsorted(before, nth, "right") - 1, np.empty(len(nth), np.int64)
        for c in np.unique(chunk):
            here = np.flatnonzero(chunk == c)
            out[here] = c * CHUNK + np.flatnonzero(self._bits(k, int(c)) == bit)[nth[here] - before[c]]
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at the given places."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            ones, bit = self._rank1(k, at)
            at, out = np.where(bit == 1, self.zeros[k] + ones, at - ones), out << 1 | bit
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        both = np.array([0, end])
        if token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            ones, _ = self._rank1(k, both)
            both = self.zeros[k] + ones if token >> (self.bits - 1 - k) & 1 else both - ones
        return int(both[0]), int(both[1])

    def rank(self, token: int, end: int) -> int:
        """How often token stands before place end."""
        lo, hi = self._range(token, end)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def occurrences(self, token: int) -> np.ndarray:
        """Places of token, ascending: select for each of its ranks, up from the lowest plane."""
        lo, hi = self._range(token, self.n)
        at = np.arange(lo, hi)
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at


def _shown_bytes() -> dict[int, str]:
    """A byte-level model knows a byte as the character of its number, or if that isn't printable, as one from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """The tokenizer's ids of texts, each distinct word of a batch looked up once and each new part encoded once.

    The tokenizer never joins across white space, nor a Latin letter and the punctuation after it, and lower-cases;
    so words are cut there and ids of the parts are put together. A tokenizer file that doesn't say so is left to
    the library, text by text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.type = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = "|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}
        self.shown = _shown_bytes()
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.by_words = self._cuts_at_words(held)

    @staticmethod
    def _cuts_at_words(held: dict) -> bool:
        pre, model = (held.get("pre_tokenizer") or {}).get("pretokenizers", []), held.get("model") or {}
        return (
            (held.get("normalizer") or {}).get("normalizers") == NORMALIZER
            and len(pre) == 2
            and (pre[0].get("type"), pre[0].get("pattern"), pre[0].get("behavior"), pre[0].get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)
            and (pre[1].get("type"), pre[1].get("add_prefix_space"), pre[1].get("use_regex")) == ("ByteLevel", False, False)
            and (model.get("type"), model.get("dropout"), model.get("continuing_subword_prefix")) == ("BPE", None, None)
        )

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, parts: list[str], lists: list[list[int]]) -> None:
        flat = np.fromiter(itertools.chain.from_iterable(lists), self.type).tobytes()
        ends = list(itertools.accumulate([len(x) * self.type.itemsize for x in lists], initial=0))
        self.known.update(zip(parts, [flat[a:b] for a, b in itertools.pairwise(ends)], strict=True))

    def _of_parts(self, parts: list[str], latin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts one after the other, and where each ends; Latin ones go to the model as they stand."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, tokenize, shown = self.known, self.library.model.tokenize, self.shown
        fresh = [(p, k) for p, k in zip(parts, latin.tolist(), strict=True) if p not in known]
        words = [p for p, k in fresh if k]
        as_bytes = [w if w.isascii() else "".join([shown[b] for b in w.encode()]) for w in words]
        self._remember(words, [[t.id for t in tokenize(w)] for w in as_bytes])
        others = [p for p, k in fresh if not k]
        self._remember(others, self._ids(others))
        held = [known[p] for p in parts]
        size = np.fromiter(map(len, held), np.int64, len(held)) // self.type.itemsize
        return np.frombuffer(b"".join(held), self.type), np.append(0, np.cumsum(size))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow array or list, nulls empty) one after the other, and the bound before each and at the end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        # a special token may hold a space
        odd = pc.match_substring_regex(column, self.special) if self.special else pa.array([False] * len(column))
        if not self.by_words:
            odd = pa.array([True] * len(column))
        alone = dict(zip(odd.to_numpy(zero_copy_only=False).nonzero()[0].tolist(), self._ids(column.filter(odd).to_pylist()), strict=True))
        if alone:
            column = pc.if_else(odd, pa.scalar("", pa.large_string()), column)
        for space in "\n\t\r":  # with the blank all that is cut at: what else counts as white space is left to the tokenizer
            column = pc.replace_substring(column, space, " ")
        lists = pc.split_pattern(column, " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        core = pc.utf8_rtrim(words, characters=PUNCTUATION)
        latin = pc.match_substring_regex(core, LATIN)
        core = pc.if_else(latin, pc.utf8_lower(core), words)
        # what follows the core of a Latin word, from its length in bytes
        cut, whole = pc.binary_length(core).to_numpy(zero_copy_only=False), pc.binary_length(words).to_numpy(zero_copy_only=False)
        tailed = np.flatnonzero(cut != whole)
        raw = [w[-n:] for w, n in zip(words.take(pa.array(tailed)).to_pylist(), (whole - cut)[tailed].tolist(), strict=True)]  # ASCII alone
        cores, tails = core.dictionary_encode(), pa.array(raw, pa.large_string()).dictionary_encode()
        is_latin = np.zeros(len(cores.dictionary), bool)
        is_latin[cores.indices.to_numpy()] = latin.to_numpy(zero_copy_only=False)
        parts = [*cores.dictionary.to_pylist(), *tails.dictionary.to_pylist()]
        flat, ends = self._of_parts(parts, np.append(is_latin, np.zeros(len(parts) - len(is_latin), bool)))
        first, last = cores.indices.to_numpy(), np.full(len(words), -1, np.int64)
        last[tailed] = tails.indices.to_numpy() + len(is_latin)
        # each distinct word: its core's ids, then its tail's
        two = np.stack([first, last], 1).ravel()
        flat, bounds = _gathered(flat, ends, two[two >= 0])
        word_ends = bounds[np.append(0, np.cumsum(1 + (last >= 0)))]
        tokens, bounds = _gathered(flat, word_ends, coded.indices.to_numpy())
        bound = bounds[lists.offsets.to_numpy()]
        if not alone:
            return tokens, bound
        each = [np.array(alone[i], self.type) if i in alone else tokens[bound[i] : bound[i + 1]] for i in range(len(column))]
        return np.concatenate([tokens[:0], *each]), np.cumsum([0, *map(len, each)])


def _gathered(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat numbered at, one after the other, and their bounds; run i is ends[i] to ends[i + 1]."""
    count = (ends[1:] - ends[:-1])[at]
    bounds = np.append(0, np.cumsum(count))
    return flat[np.repeat(ends[at] - bounds[:-1], count) + np.arange(bounds[-1])], bounds


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _gatherings(batches: Iterator, chars: int) -> Iterator:
    """Arrow batches put together to about so many bytes of text, and cut where one has more; a longer text stands alone."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(np.nan_to_num(batch.column("text").to_pandas().str.len().to_numpy(float)))
        parts = (ends // chars).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            held.append(batch.slice(a, b - a))
            size += ends[b - 1] - (ends[a - 1] if a else 0) if b > a else 0
            if size >= chars:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def id_bounds(docs: DataFrame) -> list[int]:
    """Bounds of buckets of about SHARD_DOCS neighbouring ids, fewer than MOST_BUCKETS; reads the ids alone."""
    key = F.col("doc_id").cast("long")
    parts = min(MOST_BUCKETS, -(-docs.count() // SHARD_DOCS))
    if parts < 2:
        return []
    return sorted(set(docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []))


def encoded(docs: DataFrame, path: str, bounds: list[int], end: int = END) -> DataFrame:
    """bucket, doc_id and ids (little-endian numbers of the encoder's type, the end id last) of every row."""
    import pyarrow as pa

    importable(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        enc, edges = encoder(path), np.array(bounds, np.int64)
        for some in _gatherings(batches, BATCH_CHARS):
            tokens, bound = enc.encode(some.column("text").combine_chunks())
            n = len(bound) - 1
            with_end = np.insert(tokens, bound[1:], np.array([end], enc.type)) if n else tokens
            offsets = (bound + np.arange(n + 1)) * enc.type.itemsize
            names = some.column("doc_id").combine_chunks()
            bucket = np.searchsorted(edges, names.fill_null(-(1 << 63)).to_numpy(), "right")
            at = 0
            while at < n:  # binary columns take offsets of 32 bits
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 30), "right")) - 1)
                own = (offsets[at : to + 1] - offsets[at]).astype(np.int32)
                raw = with_end[bound[at] + at : bound[to] + to].tobytes()
                ids = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(own.tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[at:to], pa.int32()), names.slice(at, to - at), ids],
                    names=["bucket", "doc_id", "ids"],
                )
                at = to
        enc.known.clear()  # workers live on, and other operators need their memory

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "bucket int, doc_id bigint, ids binary")


def write_shards(docs: DataFrame, path: str, end: int = END, folder: str | None = None) -> str:
    """Writes the shards of docs, by doc_id and then ids, and returns their folder.

    Unless given, it is a new one in the shared folder, which goes when the application ends.

    Texts are encoded where they are read, and their ids go to buckets of neighbouring doc_ids. One row for each file:
    bucket and part put the files in order, base is the number of ids before it in its bucket; doc_id and n_tokens
    are of its documents; file holds their ids. A file is a cell of a Parquet table, which any store that Spark writes to
    takes and commits as a whole. Null text counts as empty and gets the end id only; a null doc_id comes first.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    bounds = id_bounds(docs)
    kind = encoder(path).type
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
    columns = ["bucket", "part", "base", "doc_id", "n_tokens", "n", "file"]

    def run(batches: Iterator) -> Iterator:
        bucket, part, base, size = None, 0, 0, 0
        names: list = []
        ids: list[bytes] = []

        def made() -> pa.RecordBatch:
            all_ids = np.frombuffer(b"".join(ids), kind)
            row = [bucket, part, base, names, [len(i) // kind.itemsize for i in ids], len(all_ids), WaveletMatrix.pack(all_ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=columns)

        for batch in batches:
            for b, name, own in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids")), strict=True):
                if ids and (b != bucket or size > FILE_IDS):
                    yield made()
                    part, base = (part + 1, base + size) if b == bucket else (0, 0)
                    names, ids, size = [], [], 0
                bucket = b
                names.append(name)
                ids.append(own)
                size += len(own) // kind.itemsize
        if ids:
            yield made()

    folder = folder or shared_dir(spark, "shards")
    ordered = encoded(docs, path, bounds, end).repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "ids")
    files = ordered.mapInArrow(run, "bucket int, part int, base bigint, doc_id array<bigint>, n_tokens array<bigint>, n bigint, file binary")
    files.write.option("compression", "none").parquet(folder)
    return folder


def _before(files: DataFrame) -> DataFrame:
    """bucket and the ids in all buckets before it; fewer than MOST_BUCKETS rows."""
    total = files.groupBy("bucket").agg(F.sum("n").alias("n"))
    return total.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))


def read_shards(spark, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start (ids before it), n_tokens and ids_crc32 of each document, and its ids if asked, from the files."""
    import pyarrow as pa

    importable(spark)
    files = spark.read.parquet(folder)
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if ids else [])]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for k in range(batch.num_rows):
                names, counts, before, data = (batch.column(c)[k].as_py() for c in ("doc_id", "n_tokens", "before", "file"))
                all_ids = WaveletMatrix(data).all()
                ends = np.cumsum(np.array(counts, np.int64))
                starts = ends - counts
                own = [all_ids[a:b].astype("<u4") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                values = [names, starts + before, counts, [zlib.crc32(o.data) for o in own], *([own] if ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, kinds, strict=True)], names=[c for c, _ in kinds])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if ids else "")
    placed = files.join(F.broadcast(_before(files)), "bucket")
    return placed.select("doc_id", "n_tokens", (F.col("before") + F.col("base")).alias("before"), "file").mapInArrow(run, schema)


def look_up(spark, folder: str, token: int) -> DataFrame:
    """place (in all ids) of every occurrence of token, by count and select on the files; no file is inflated whole."""
    import pyarrow as pa

    importable(spark)
    files = spark.read.parquet(folder)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for before, data in zip(batch.column("before").to_pylist(), batch.column("file").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(WaveletMatrix(data).occurrences(token) + before, pa.int64())], names=["place"])

    return (
        files.join(F.broadcast(_before(files)), "bucket")
        .select((F.col("before") + F.col("base")).alias("before"), "file")
        .mapInArrow(run, "place bigint")
    )


def op5_token_shards(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files written; null text has the end id only."""
    docs = documents(spark, sf_dir)
    return read_shards(spark, write_shards(docs, tokenizer_file(MODEL)))
