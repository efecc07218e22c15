"""Benchmark decontamination: windows of normalised test words looked up in a broadcast hash set.

Each text is split once; the hash of every window is tested against a bit map of the test windows inside the
scan, and what passes is verified word by word in a broadcast hash join. Built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, constant, documents, row_key, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Test windows up to this number are broadcast (about 100 bytes each); beyond it they are shuffled.
MAX_BROADCAST = 500_000
#: Bits of the bit map for each test window, and the log of the most that it may have (512 KB); with more test
#: windows than that more of the others pass it, and the join drops them.
SPARSE, MOST_BITS = 256, 22


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _windows(words: Column, size: Column | int) -> Column:
    """Starts (from 1) and hashes of all windows of so many words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.xxhash64(F.slice(words, i, size)).alias("hash")))


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size, hash and gram of each window of each item; an item of fewer words is one window."""
    w = (
        items.select("item_id", words_of(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .withColumn("size", F.least(F.size("w"), F.lit(window)))
    )
    return (
        w.select("item_id", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("i"))
        .select("item_id", "size", F.slice("w", F.col("i"), F.col("size")).alias("gram"))
        .select("item_id", "size", F.xxhash64("gram").alias("hash"), F.array_join("gram", " ").alias("gram"))
    )


def _bitmap(grams: DataFrame, slots: int) -> list[int]:
    slot = F.col("hash").bitwiseAND(slots - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    out = [0] * (slots // 64)
    for at, mask in grams.select(F.shiftright(slot, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit")).collect():
        out[at] = mask
    return out


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """docs, or its columns carry, with n_words, hit (distinct positions of hit words, from 1) and items (ids as sorted strings).

    A null text and a text without words have no hits; so has every text if items is empty or has no words.
    Rows, repeated ones too, stay as they are; columns named n_words, hit and items are replaced.
    """
    grams = test_windows(items, window)
    by_gram = grams.groupBy("size", "hash", "gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("of"))
    sized = by_gram.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()  # window sizes are 1 to window
    slots = 1 << min(MOST_BITS, max(6, (SPARSE * sized["n"]).bit_length()))
    bits = constant(_bitmap(grams, slots), "array<bigint>")
    by_gram = F.broadcast(by_gram) if sized["n"] <= MAX_BROADCAST else by_gram

    def passes(hashed: Column) -> Column:
        slot = hashed["hash"].bitwiseAND(slots - 1)
        return F.call_function("shiftright", bits[F.shiftright(slot, 6).cast("int")], slot.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    own = [c for c in carry or docs.columns if c not in ("n_words", "hit", "items")]
    split = docs.select(F.struct(*own).alias("doc"), words_of(F.col("text")).alias("w")).withColumn("row", row_key())
    none = F.array().cast("array<struct<start:int,size:int,hash:bigint,gram:string>>")

    def met_by(size: int) -> Column:
        passed = F.filter(_windows(F.col("w"), size), passes)
        return F.transform(
            passed,
            lambda c: F.struct(c["start"].alias("start"), F.lit(size).alias("size"), c["hash"].alias("hash"), F.array_join(F.slice("w", c["start"], size), " ").alias("gram")),
        )

    possible = reduce(F.concat, [met_by(n) for n in sorted(sized["sizes"])], none)
    met = (
        split.select("row", "doc", F.size("w").cast("long").alias("n_words"), F.explode_outer(possible).alias("c"))
        .select("row", F.col("doc"), "n_words", F.col("c.start").alias("start"), F.col("c.size").alias("size"), F.col("c.hash").alias("hash"), F.col("c.gram").alias("gram"))
        .join(by_gram, ["size", "hash", "gram"], "left")
    )
    covered = F.when(F.col("of").isNotNull(), F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))
    return (
        met.groupBy("row")
        .agg(
            F.first("doc").alias("doc"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(covered)))).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("of")))).alias("items"),
        )
        .select("doc.*", "n_words", "hit", "items")
    )


def remove_spans(found: DataFrame) -> DataFrame:
    """find()'s rows with the hit words, and what lies between two of them, cut from text; other text stays as it was."""
    word, text = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", F.coalesce("text", F.lit(""))
    gaps, words = F.split(text, word, -1), F.regexp_extract_all(text, F.lit(word), F.lit(0))
    hit = F.transform(F.sequence(F.lit(1), F.size(gaps)), lambda i: F.array_contains("hit", i))
    once = F.array(F.struct(gaps.alias("gaps"), words.alias("words"), hit.alias("hit")))  # bound by the outer transform, not made anew for each word

    def kept(x: Column) -> Column:
        def piece(gap: Column, i: Column) -> Column:
            now, before = F.get(x["hit"], i), F.coalesce(F.get(x["hit"], i - 1), F.lit(False))
            return F.concat(
                F.when(now & before, F.lit("")).otherwise(gap),
                F.when(now, F.lit("")).otherwise(F.coalesce(F.get(x["words"], i), F.lit(""))),
            )

        return F.array_join(F.transform(x["gaps"], piece), "")

    return found.withColumn("text", F.when(F.size("hit") > 0, F.element_at(F.transform(once, kept), 1)).otherwise(F.col("text")))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of every document; a null text has no words."""
    found = find(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), s AS (
  SELECT DISTINCT size FROM g
), c AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, s WHERE len(w) >= size)
), m AS (
  SELECT doc_id, item_id, i, size FROM c JOIN g USING (size, gram)
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY 1
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
