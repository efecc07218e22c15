"""Document fingerprints: a threshold-scaled sketch of word shingles.

A sketch holds every shingle hash below a fixed fraction of the hash range, so sketches of very unequal
documents are comparable, their union is the sketch of both texts together, and shares of common hashes
estimate likeness and containment. A text without such a hash has its smallest one as a stand-in, which is at
or above the threshold and so told apart: it serves to tell short texts apart, drops out of a union that has
hashes below the threshold, and never counts beside them. Built-in functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import constant, documents
from .decontaminate import words_of

WORDS, SCALE = 5, 8
#: Rows of a bucket of neighbouring ids, and the most bounds of buckets that reach the driver.
BUCKET_ROWS, MOST_BOUNDS = 2000, 16_384
LEAST, TOP = -(1 << 63), 1 << 63


def _kept(hashes: Column, scale: int) -> Column:
    """Of distinct or repeated hashes those below the threshold, sorted; the smallest of all where there is none."""
    low = F.filter(hashes, lambda x: x <= TOP // scale - 1)
    one = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(one)


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """Sorted distinct hashes (63 bits) below 1/scale of the range; the smallest alone where there is none.

    Fewer words than a shingle's make one shingle; no words or a null text, an empty sketch.
    """
    hashed = F.transform(words_of(text), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]).bitwiseAND(TOP - 1),
        )
        return F.when(F.size(h) > 0, many).otherwise(F.array().cast("array<bigint>"))

    # each array is bound once, by a transform over an array of one
    bound = F.transform(F.array(hashed), shingles)
    return F.element_at(F.transform(bound, lambda s: _kept(s, scale)), 1)


def is_stand_in(s: Column, scale: int = SCALE) -> Column:
    """Whether the text of s has no hash below the threshold, so s estimates little: its smallest hash, or nothing."""
    return F.coalesce(F.get(s, F.lit(0)) > TOP // scale - 1, F.lit(True))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Share of common hashes among all of two sketches, an estimate of the texts' likeness.

    Of two stand-ins, 1 if they are the same and else 0; of a stand-in beside hashes below the threshold, 0. Two
    empty ones are alike, an empty one and any other not.
    """
    both = F.size(F.array_intersect(a, b))
    alone = is_stand_in(a, scale) != is_stand_in(b, scale)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(alone, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Share of a's hashes that b has, an estimate of how much of a's text stands in b's, however much longer b's is.

    An empty sketch is contained in any. Null where a is a stand-in and b isn't: b doesn't hold such hashes.
    """
    share = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(~is_stand_in(a, scale) | is_stand_in(b, scale), share)


def merged(sketches: Column, scale: int = SCALE) -> Column:
    """Sketch of several texts' shingles together, from an array of their sketches."""
    return F.element_at(F.transform(F.array(F.flatten(sketches)), lambda s: _kept(s, scale)), 1)


def written(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds key reaches, by a coarse and a fine look."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    edges, coarse = constant(bounds, "array<bigint>"), constant(bounds[::width], "array<bigint>")
    reached = F.greatest(F.size(F.filter(coarse, lambda b: b <= key)) - 1, F.lit(0)) * width
    return F.element_at(F.transform(F.array(reached), lambda r: r + F.size(F.filter(F.slice(edges, r + 1, F.lit(width)), lambda b: b <= key))), 1)


def with_next(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """docs with columns, made of text and doc (a struct of the rest), and next, a struct of these of the row after it.

    Order is by doc_id, then text; the first follows the last. Buckets of neighbouring ids are put in order apart
    from each other; the first row of each also goes to the bucket before it. Rows go to their buckets before columns
    are made. A null doc_id comes first. One row of all is its own next. Rows of one doc_id are in one bucket. Columns
    of docs that have the names of columns, or next, in any case, are replaced.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    n, least = docs.agg(F.count("*"), F.min(key)).first()
    parts = max(1, min(MOST_BOUNDS, n // BUCKET_ROWS))
    bounds = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    bounds = sorted({b for b in bounds if b > least})
    at = F.struct(key.alias("key"), _bucket_of(key, bounds).alias("bucket"))
    previous = F.when(F.col("at.key") == F.lit(least), F.lit(len(bounds)))
    if bounds:
        previous = previous.when(F.array_contains(constant(bounds, "array<bigint>"), F.col("at.key")), F.col("at.bucket") - 1)
    own = F.struct(F.lit(0).alias("guest"), F.col("at.bucket").alias("bucket"))
    taken = {"next", *map(str.lower, columns)}
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    keyed = docs.select(doc.alias("doc"), F.col("text").cast("string").alias("text"), at.alias("at"))
    guest = F.struct(F.lit(1).alias("guest"), previous.alias("bucket"))
    placed = keyed.select("doc", "text", "at.key", F.explode(F.when(previous.isNotNull(), F.array(own, guest)).otherwise(F.array(own))).alias("to"))
    dealt = placed.select("doc", "text", "key", "to.guest", "to.bucket").repartition("bucket")
    ready = dealt.select("doc", "text", "key", "guest", "bucket", F.struct(*[c.alias(name) for name, c in columns.items()]).alias("own"))
    w = Window.partitionBy("bucket").orderBy("guest", "key", "text")
    return ready.withColumn("next", F.lead("own").over(w)).where("guest = 0").select("doc.*", "own.*", "next")


def op8_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses; a null text counts as empty."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ready = with_next(docs, {"given": F.col("text"), "s": sketch(F.col("text"))})
    n = F.char_length("given")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("given", n - half), F.left("next.given", half))
    made = ready.select("doc_id", n.cast("long").alias("n_chars"), "s", F.col("next.s").alias("next_s"), edited.alias("edited"))
    # the sketch of the edited text serves twice
    made = made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "s",
        "next_s",
        F.explode(F.array(sketch(F.col("edited")))).alias("e"),
    )
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("s")).alias("fingerprint"),
        written(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"),
        likeness(F.col("s"), F.col("next_s")).alias("near_next"),
    )
