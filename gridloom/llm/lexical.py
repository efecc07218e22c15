"""Ranked lexical search by the Best Position Algorithm over impact lists.

One pass counts documents, terms and, for the items' terms, the documents that hold them; from these numbers every
task builds impact lists of its own documents, PART at a time: for each term its documents in the order of what the term
adds to their score. An item's lists are read side by side, some places further in each round. Each document that comes
up is scored at once by direct access to all its lists, and its places there count as seen; a list's best position is
the last up to which every place is seen. No unseen document can score more than the sum of what stands at the best
positions, so reading stops when that is strictly below the k-th score found so far. A task keeps its k best of each
item from part to part, so later parts stop sooner; what is kept meets in one sort of k rows an item and task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import UPPER, documents, importable, row_key, slices, stored, table

#: Documents and postings whose impact lists a task holds at once (one batch more at most), places read in the first round (doubled in each).
PART, POSTINGS, STEP = 8192, 4_000_000, 64
#: Characters whose terms are counted at once.
BATCH_CHARS = 4_000_000
#: Distinct pairs of item and term that a pass over the documents looks for; more items take more passes.
MOST_TERMS = 200_000
#: Byte to byte: what belongs to no term becomes a space, A-Z become lower case; bytes beyond ASCII belong to terms.
FOLDED = bytes(b + 32 if chr(b) in UPPER else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLDED).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """item (a row's number), item_id and the distinct terms of each row that has any."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [sorted(set(terms_of(t))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    kind = dict(items.dtypes)["item_id"]
    found = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, terms array<binary>")
    return found.where(F.size("terms") > 0).select(row_key().alias("item"), "item_id", "terms")


def _counted(texts: list[str | None], known: dict[bytes, int]) -> tuple[np.ndarray, ...]:
    """Of all texts' postings of known terms text, term and count; and each text's number of terms."""
    text, term, count, sizes = [], [], [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        words = terms_of(t)
        sizes[k] = len(words)
        got = Counter(filter(known.__contains__, words))
        text += [k] * len(got)
        term += [known[w] for w in got]
        count += got.values()
    return np.array(text, np.int64), np.array(term, np.int64), np.array(count, np.int64), sizes


def _statistics(docs: DataFrame, known: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each known term."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n = total = 0
        df = np.zeros(len(known), np.int64)
        for b in slices(batches, BATCH_CHARS):
            _, term, _, sizes = _counted(b.column("text").to_pylist(), known)
            df += np.bincount(term, minlength=len(known))
            n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *held], pa.int64()), pa.array([n, total, *df[held]], pa.int64())], names=["term", "many"])

    got = dict(docs.select("text").mapInArrow(run, "term bigint, many bigint").groupBy("term").agg(F.sum("many")).collect())
    df = np.zeros(len(known), np.int64)
    for term, many in got.items():
        if term >= 0:
            df[term] = many
    return got.get(-2) or 0, got.get(-1) or 0, df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    """What a term that so many of n documents hold weighs."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def lengths(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of so many terms, in numbers of any length."""
    own, at = np.unique(sizes, return_inverse=True)
    return np.array([100 - 50 + (50 * s * n) // total for s in own.tolist()], np.int64)[at] if len(own) else own


class Lists:
    """Impact lists of some documents: the postings by term, greatest impact first, and by document the same postings."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, rank: np.ndarray):
        """rank orders the documents, as equal impacts are listed."""
        order = np.lexsort((rank[doc], -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.terms, self.start, self.term = np.unique(term[order], return_index=True, return_inverse=True)
        self.end = np.append(self.start[1:], len(order))
        self.forward = np.argsort(self.doc, kind="stable")
        many = np.bincount(self.doc, minlength=len(rank))
        self.first, self.many = np.cumsum(many) - many, many

    def _postings(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct access: all postings of the documents, and where each document's begin."""
        many = self.many[docs]
        begin = np.cumsum(many) - many
        return self.forward[np.repeat(self.first[docs] - begin, many) + np.arange(many.sum())], begin

    def search(self, wanted: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the k best for the terms, their scores, and how many postings were read in order.

        floor holds the greatest scores found elsewhere, k or fewer, ascending; a document that scores what the k-th
        does is still found.
        """
        lists = np.flatnonzero(np.isin(self.terms, wanted))
        start, end = self.start[lists], self.end[lists]
        mine, seen, met = np.zeros(len(self.terms), bool), np.zeros(len(self.doc), bool), np.zeros(len(self.first), bool)
        mine[lists] = True
        best, at, step, read = start.copy(), start.copy(), STEP, 0
        docs, scores, top = [], [], floor
        while (at < end).any():
            upto = np.minimum(at + step, end)
            places = np.concatenate([np.arange(a, b) for a, b in zip(at, upto, strict=True)])
            read, at, step = read + len(places), upto, 2 * step
            fresh = np.unique(self.doc[places])
            fresh = fresh[~met[fresh]]
            if len(fresh):
                met[fresh] = True
                own, begin = self._postings(fresh)
                counts = mine[self.term[own]]
                seen[own[counts]] = True
                found = np.add.reduceat(np.where(counts, self.impact[own], 0), begin)
                docs.append(fresh)
                scores.append(found)
                top = np.sort(np.append(top, found))[-k:]
            for j, (b, e) in enumerate(zip(best.tolist(), end.tolist(), strict=True)):
                while b < e and seen[b]:  # further in strides: the first place not seen
                    gap = seen[b : b + 4096].argmin()
                    b += int(gap) if not seen[b + gap] else len(seen[b : b + 4096])
                best[j] = min(b, e)
            bound = int(self.impact[best - 1][best < end].sum())
            if len(top) >= k and bound < top[0]:
                break
        return (np.concatenate(docs), np.concatenate(scores), read) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64), read)


def _best(docs: DataFrame, found: list, known: dict[bytes, int], k: int) -> DataFrame:
    """item, doc_id and score of the k best documents of each task for each of the items (number, places of its terms)."""
    n, total, df = _statistics(docs, known)
    if not n:
        return docs.sparkSession.createDataFrame([], "item bigint, doc_id bigint, score bigint")
    weight = weights(n, df)
    last = np.iinfo(np.int64).max

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def searched() -> None:
            before = np.cumsum([0, *(len(h[-1]) for h in held)])
            doc = np.concatenate([h[0] + b for h, b in zip(held, before, strict=False)])
            term, count, sizes, id_ = (np.concatenate([h[j] for h in held]) for j in range(1, 5))
            held.clear()
            m = lengths(sizes, n, total)
            lists = Lists(doc, term, weight[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m[doc])), np.argsort(np.argsort(id_, kind="stable"), kind="stable"))
            for item, terms in found:
                own_id, own = kept.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                at, score, _ = lists.search(terms, k, own[::-1])
                own_id, own = np.append(own_id, id_[at[score > 0]]), np.append(own, score[score > 0])
                order = np.lexsort((own_id, -own))[:k]
                kept[item] = own_id[order], own[order]

        for b in slices(batches, BATCH_CHARS):
            id_ = b.column("doc_id").fill_null(last).to_numpy()
            held.append((*_counted(b.column("text").to_pylist(), known), id_))
            if sum(len(h[-1]) for h in held) >= PART or sum(len(h[0]) for h in held) >= POSTINGS:
                searched()
        if held:
            searched()
        for item, (own_id, own) in kept.items():
            none = own_id == last
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), item)), pa.array(own_id, mask=none), pa.array(own)], names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, k: int, most_terms: int = MOST_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item with a score above 0.

    Equal scores go by ascending doc_id, a null one last. Every row of docs is a document, repeated ones too, every
    row of items an item; null and empty texts have no terms, so such items and documents, and empty tables, give
    no rows. Other columns aren't looked at.
    """
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = stored(_item_terms(items), "items")
    parts = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // most_terms))
    best = None
    for part in range(parts):  # one pass, unless the items are more than a task should hold
        some = asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).select("item", "terms").collect()
        known = {t: j for j, t in enumerate(sorted({bytes(t) for r in some for t in r["terms"]}))}
        found = [(r["item"], np.array([known[bytes(t)] for t in r["terms"]])) for r in some]
        here = _best(docs, found, known, k)
        best = here if best is None else best.unionByName(here)
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical(spark, sf_dir: str, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item of the benchmark."""
    return rank(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), k)


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, row_number() OVER () AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (
  SELECT DISTINCT item_id, item, unnest(w) AS term FROM b
), s AS (
  SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS total FROM d
), t AS (
  SELECT doc_id, row, len, term, count(*) AS tf FROM (SELECT doc_id, row, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL
), f AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM t, s GROUP BY 1
), r AS (
  SELECT item_id, item, doc_id, row, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len * n) // total)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN f USING (term), s GROUP BY 1, 2, 3, 4
)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS k FROM r WHERE score > 0) WHERE k <= 50
"""
