"""SentencePiece BPE by vectorised merge rounds, exactly as the library encodes.

All distinct words of a batch lie one after the other in flat numpy arrays. A round looks up the rank of every
neighbouring pair, takes the least rank of each word (a segmented minimum), joins that pair wherever it stands
in the word, leftmost first, and compacts the arrays; words without a pair drop out. Joining at once is what
the library does one by one, except where the joined piece could join again at an equal or better rank: of
such pairs only the leftmost is joined in a round.

A word of more than LONG characters has a minimum for each pair instead, over as many neighbours as the longest piece has
characters: what is joined first further away never reaches it, as no piece is that long. So the rounds don't
grow with the word, and its time is in proportion to its length.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, importable, slices, tokenizer_file

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words whose ids a task remembers, about 70 MB; it starts anew beyond that.
REMEMBERED = 200_000
#: Texts are encoded in batches of about so many characters.
BATCH_CHARS = 4_000_000
#: Characters of a word beyond which pairs are held against their neighbours, not against all of the word.
LONG = 256


class Encoder:
    """Encoder and decoder of one model file. Unknown characters become their bytes; no piece crosses a word."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        ordinary = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.id_of = {pieces[i]: i for i in ordinary}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of):
            raise ValueError("a piece of this model crosses words")
        self.byte_id = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.first_byte, self.last_byte = int(self.byte_id[0]), int(self.byte_id[-1])
        if (np.diff(self.byte_id) != 1).any():
            raise ValueError("the byte pieces of this model are not in a row")
        self.end = lib.eos_id()
        # symbols: the pieces by id, then n plus the code of each further character
        singles = {c for p in self.id_of for c in p}
        if any(c not in self.id_of for c in singles):
            raise ValueError("a character of a piece of this model is no piece")
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for c in singles:
            self.symbol[ord(c)] = self.id_of[c]
        scores = sorted({lib.get_score(i) for i in ordinary}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        rank = {p: rank_of[lib.get_score(i)] for p, i in self.id_of.items()}
        keys, ranks, made = [], [], []
        for piece, i in self.id_of.items():
            for cut in range(1, len(piece)):
                a, b = self.id_of.get(piece[:cut]), self.id_of.get(piece[cut:])
                # a single character is a symbol of its own even if it is no piece; such pairs get their rows on demand
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(rank[piece])
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks, self.made = np.array(keys, np.int64)[order], np.array(ranks, np.int32)[order], np.array(made, np.int32)[order]
        self.n, self.none = n, len(scores)
        self.longest = max(map(len, self.id_of))
        again = np.zeros(n, bool)  # pieces that can join again at an equal or better rank
        own = np.full(n, self.none, np.int32)
        for p, i in self.id_of.items():
            own[i] = rank[p]
        for side in (self.keys // n, self.keys % n):
            np.logical_or.at(again, side, self.ranks <= own[side])
        self.again = again
        self.apart = self._apart()
        self.parts = re.compile(f"{SPACE}*[{self.apart}]+|{SPACE}*[^{self.apart}{SPACE}]+|{SPACE}+") if self.apart else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.spelled = [str(i) for i in range(n)]
        self.text_of = [lib.id_to_piece(i).replace(SPACE, " ") for i in range(n)]
        self.known: dict[str, tuple[str, str]] = {}

    def _apart(self) -> str:
        """Other ASCII characters than letters and digits that no piece joins to one outside them, as a regex class."""
        found = {chr(c) for c in range(128) if not chr(c).isalnum()}
        while True:
            mixed = {c for p in self.id_of for pair in zip(p, p[1:], strict=False) for c in pair if c in found and not set(pair) <= found | {SPACE}}
            if not mixed:
                return "".join(map(re.escape, sorted(found)))
            found -= mixed

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair in the table of pairs, or -1."""
        key = left.astype(np.int64) * self.n + right
        key[(left >= self.n) | (right >= self.n)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1).astype(np.int32)
        at[self.keys[at] != key] = -1
        return at

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each pair, and its rank, none for what is no pair."""
        row = self._pairs(left, right)
        rank = self.ranks[row]
        rank[row < 0] = self.none
        return row, rank

    def _long(self, sym: np.ndarray) -> np.ndarray:
        """Symbols of one long word after all rounds.

        A pair is due if no pair within reach has a better rank, and none of those that overlap it from the left, with one
        rank, has to wait. Pairs due within reach of each other have one rank, and
        the library would join them from the left; so are they here, up to the first whose piece can join a neighbour at
        an equal or better rank, for that would come before the pairs to the right of it.
        """
        reach = self.longest
        row, rank = self._ranked(sym[:-1], sym[1:])
        while len(row) and rank.min() < self.none:
            least, width = np.pad(rank, reach, constant_values=self.none), 1
            while 2 * width <= 2 * reach + 1:
                least, width = np.minimum(least[:-width], least[width:]), 2 * width
            rest = 2 * reach + 1 - width
            least = np.minimum(least[: len(least) - rest], least[rest:])
            due, heads = (rank == least) & (rank < self.none), np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            # pairs of one rank that overlap decide from the left which of them are joined, however many they are
            late = np.cumsum(~due)
            before = np.repeat(late[heads] - ~due[heads], np.diff(np.append(heads, len(rank))))
            at = np.flatnonzero(due & (late == before))
            # of a chain of overlapping pairs each other one is joined
            start = np.flatnonzero(np.append(True, np.diff(at) > 1))
            at = at[(np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 0]
            new, own = self.made[row[at]], rank[at]
            close = np.append(False, np.diff(at) <= reach)
            before = np.where(np.append(False, np.diff(at) == 2), np.append(0, new[:-1]), sym[np.maximum(at - 1, 0)])
            again = (self._ranked(before, new)[1] <= own) & (at > 0)
            again |= (self._ranked(new, sym[np.minimum(at + 2, len(sym) - 1)])[1] <= own) & (at + 2 < len(sym))
            if again.any():  # those after the first of these in each group that lies together wait
                group = np.cumsum(~close) - 1
                seen = np.cumsum(again) - again
                waits = seen > seen[np.flatnonzero(~close)][group]
                at, new = at[~waits], new[~waits]
            sym[at] = new
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, changed = sym[keep], place[at]
            row, rank = row[keep[1:]], rank[keep[1:]]  # the pair that ends with a symbol goes with it
            changed = np.unique(np.concatenate([changed[changed > 0] - 1, changed[changed < len(row)]]))
            row[changed], rank[changed] = self._ranked(sym[changed], sym[changed + 1])
        return sym

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words one after the other, and where each word ends."""
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._short(words)
        sym, ends = self._short([w if len(w) <= LONG else "" for w in words])
        parts = np.split(sym, ends[:-1])
        for k in long:
            parts[k] = self._long(self.symbol[np.frombuffer(words[k].encode("utf-32-le", "surrogatepass"), np.uint32)])
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def _short(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """merged() with one minimum for each word."""
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            row = np.append(self._pairs(sym[:-1], sym[1:]), np.int32(-1))
            edge = word[1:] != word[:-1]
            row[:-1][edge] = -1
            rank = self.ranks[row]
            rank[row < 0] = self.none
            first = np.flatnonzero(np.append(True, edge))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(word)))
            alive = least < self.none
            if not alive.all():
                live = np.repeat(alive, length)
                done.append((word[~live], sym[~live]))
                sym, word, rank, row = sym[live], word[live], rank[live], row[live]
                length, least = length[alive], least[alive]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, length))
            new, of = self.made[row[at]], word[at]
            # of a chain of overlapping pairs each other one is joined
            start = np.flatnonzero(np.append(True, np.diff(at) > 1))
            place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            # a word with a piece that can join again joins its leftmost pair only
            single = np.zeros(word[-1] + 1, bool)
            single[of[self.again[new]]] = True
            join = np.where(single[of], np.append(True, of[1:] != of[:-1]), place % 2 == 0)
            at = at[join]
            sym[at] = new[join]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        word, sym = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int32) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        return sym[order], np.cumsum(np.bincount(word, minlength=len(words)))

    def _learn(self, words: list[str]) -> None:
        """Remembers ids and decoded text of words."""
        sym, ends = self.merged(words)
        if len(sym) and sym.max() >= self.n:  # byte by byte
            spelled = [self.spelled[i] if i < self.n else " ".join(map(str, self.byte_id[list(chr(i - self.n).encode())])) for i in sym.tolist()]
        else:
            spelled = [self.spelled[i] for i in sym.tolist()]
        at = 0
        for w, end in zip(words, ends.tolist(), strict=True):
            ids = " ".join(spelled[at:end])
            self.known[w] = ids, self._decoded(ids)
            at = end

    def _decoded(self, ids: str) -> str:
        """Text of the ids of whole words; runs of bytes are decoded together."""
        if not ids:
            return ""
        numbers = [*map(int, ids.split(" "))]
        if max(numbers) > self.last_byte and min(numbers) > self.last_byte:
            return "".join([self.text_of[i] for i in numbers])
        return "".join([bytes([i - self.first_byte for i in run]).decode("utf-8", "replace") if is_byte else "".join([self.text_of[i] for i in run]) for is_byte, run in self._runs(numbers)])

    def _runs(self, numbers: list[int]) -> list[tuple[bool, list[int]]]:
        return [(k, [*g]) for k, g in itertools.groupby(numbers, lambda i: self.first_byte <= i <= self.last_byte)]

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Of each text the decimal ids with the end id, joined by one space, and the text decoded from them."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, cut = self.known, self.parts.findall
        names = []
        for t in texts:
            ws = t.replace(" ", SPACE).split(SPACE) if t else []
            # a run of spaces leaves empty words; it goes with what follows it
            names.append(cut(SPACE + SPACE.join(ws)) if "" in ws else [SPACE + w for w in ws])
        fresh = {w: cut(w) for ws in names for w in ws if w not in known}
        parts = [*{p for ps in fresh.values() for p in ps if p not in known}]
        for at in range(0, len(parts), 50_000):
            self._learn(parts[at : at + 50_000])
        for w, ps in fresh.items():
            if len(ps) > 1:
                known[w] = " ".join([known[p][0] for p in ps]), "".join([known[p][1] for p in ps])
        end = str(self.end)
        out = []
        for ws in names:
            got = [known[w] for w in ws]
            out.append((" ".join([*[g[0] for g in got], end]), "".join([g[1] for g in got])[1:]))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and with ids and decoded if texts; without its text.

    Null text counts as empty and has the end id only. Every row gives one row.
    """
    import pyarrow as pa

    importable(docs.sparkSession)
    own = docs.drop("text", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    more = ", ids string, decoded string" if texts else ""
    schema = ", ".join([*[f"`{n}` {t}" for n, t in own.dtypes], "n_tokens bigint, ids_sha256 string, decoded_sha256 string"]) + more

    def run(frames: Iterator) -> Iterator:
        enc = encoder(path)
        for part in slices(frames, BATCH_CHARS):
            ids, decoded = zip(*enc.encode([t or "" for t in part.column("text").to_pylist()]), strict=True)
            sha = lambda values: pa.array([hashlib.sha256(v.encode()).hexdigest() for v in values], pa.string())
            made = [pa.array([i.count(" ") + 1 for i in ids], pa.int64()), sha(ids), sha(decoded)]
            made += [pa.array(ids, pa.string()), pa.array(decoded, pa.string())] if texts else []
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in names], *made],
                names=[*names, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if texts else [])],
            )
        enc.known.clear()  # workers live on, and other operators need their memory

    return docs.select(*own.columns, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every document; a null text has the end id only."""
    docs = documents(spark, sf_dir)
    return tokenize(docs, tokenizer_file(MODEL)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
